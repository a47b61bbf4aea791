"""Risk gates over all keys at once: one ordered state machine, run in ranges of time.

Whether a signal may open a position depends on what the signals before it were allowed to do: positions still open,
openings of the last minutes, what closed positions have lost, how the latest of them ended, and a cooldown after a trip.
No window function says that, and one task must not read all rows. So time is cut into ranges. A range is run from a
supposed start state and summarised as a piece of its transition function: start state, end state, by how much it moves the
loss, and the interval of losses so far for which every one of its decisions stays the same. The driver composes the
summaries in order - they are few and of fixed size - and ranges whose real start state or loss is not covered are run again,
each from what its predecessor now ends with. Each round settles one more range for certain; because positions close and
minutes pass, a few rounds settle all. A last pass gives every row its verdict.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept

VERDICTS = ("fire", "cooldown", "concurrent", "rate", "loss", "failures")


@dataclass(frozen=True)
class Rules:
    """At most ``concurrent`` positions at once and ``fires`` in ``per`` seconds. With ``least`` closed positions, a loss
    of ``loss`` or worse trips the gate; so does a share of failures above ``fail_rate`` among the last ``window`` closed.
    A trip refuses all for ``cooldown`` seconds."""

    concurrent: int = 5
    fires: int = 10
    per: float = 60.0
    loss: float = -1.0
    least: int = 5
    window: int = 20
    fail_rate: float = 0.5
    cooldown: float = 1800.0


@dataclass
class State:
    """What the machine remembers, loss apart: of fixed size."""

    until: float = -math.inf
    open: list = field(default_factory=list)  # (close, order of opening, gain, failed), by close
    recent: list = field(default_factory=list)  # openings of the last ``per`` seconds
    closed: int = 0  # up to ``least``
    last: list = field(default_factory=list)  # failures of the last ``window`` closed

    def key(self) -> tuple:
        return (self.until, tuple((c, g, f) for c, _, g, f in self.open), tuple(self.recent), self.closed, tuple(self.last))


def step(s: State, lost: float, t: float, close: float, gain: float, failed: bool, order: int, rules: Rules) -> tuple[int, float, float | None]:
    """One signal at ``t``: its verdict, the loss after positions that have closed by then, and the loss that was compared
    with the limit (None: not compared). Changes ``s``."""
    while s.open and s.open[0][0] <= t:
        _, _, g, bad = s.open.pop(0)
        lost += g
        s.closed = min(rules.least, s.closed + 1)
        s.last = [*s.last, bad][-rules.window :]
    s.recent = [x for x in s.recent if x >= t - rules.per]
    if t < s.until:
        return 1, lost, None
    if len(s.open) >= rules.concurrent:
        return 2, lost, None
    if len(s.recent) >= rules.fires:
        return 3, lost, None
    asked = lost if s.closed >= rules.least else None
    if asked is not None and lost <= rules.loss:
        s.until = t + rules.cooldown
        return 4, lost, asked
    if len(s.last) >= rules.window and sum(s.last) / len(s.last) > rules.fail_rate:
        s.until = t + rules.cooldown
        return 5, lost, asked
    s.open.append((close, order, gain, failed))
    s.open.sort(key=lambda x: x[:2])
    s.recent.append(t)
    return 0, lost, asked


def _run(rows: pd.DataFrame, s: State, lost: float, rules: Rules) -> tuple[list[int], State, float, float, float]:
    """Verdicts, end state, the loss at the end, and between which starting losses (above low, up to high) all stay as they are."""
    start, low, high, out = lost, -math.inf, math.inf, []
    order = len(s.open)
    for t, close, gain, failed in zip(rows["t"].tolist(), rows["close"].tolist(), rows["gain"].tolist(), rows["failed"].tolist(), strict=True):
        verdict, lost, asked = step(s, lost, t, close, gain, failed, order, rules)
        order += 1
        if asked is not None:
            edge = start + (rules.loss - asked)  # the starting loss at which this comparison turns
            if asked <= rules.loss:
                high = min(high, edge)
            else:
                low = max(low, edge)
        out.append(verdict)
    s.open = [(c, k, g, f) for k, (c, _, g, f) in enumerate(s.open)]
    return out, s, lost, low, high


def _pack(s: State) -> dict:
    return {"until": s.until, "open": [[c, g, f] for c, _, g, f in s.open], "recent": s.recent, "closed": s.closed, "last": s.last}


def _unpack(d: dict) -> State:
    return State(d["until"], [(c, k, g, f) for k, (c, g, f) in enumerate(d["open"])], list(d["recent"]), d["closed"], list(d["last"]))


def _ranges(signals: DataFrame, order: list[str]) -> DataFrame:
    """``signals`` with ``part``, rising with ``order``; each part's rows lie in one partition, in order."""
    n = max(2, int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept(signals.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def decide(signals: DataFrame, rules: Rules, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """``signals`` (t, close, gain, failed, and what ``order`` names, which tells all rows apart) with ``verdict``: "fire", or
    the first rule that refuses. ``close`` is when a position opened here would end, ``gain`` what it would bring, ``failed``
    whether it would count as a failure. Times are not null; a null gain is 0, a null failed false; the table may be empty."""
    columns = signals.columns
    clean = signals.withColumns({"gain": F.coalesce("gain", F.lit(0.0)), "failed": F.coalesce("failed", F.lit(False))})
    rows = _ranges(clean, list(order))
    parts = sorted(r.part for r in rows.select("part").distinct().collect())  # as many as there are ranges
    known: dict[int, tuple[tuple, float, float, dict, float]] = {}
    starts: dict[int, tuple[dict, float]] = {p: (_pack(State()), 0.0) for p in parts}
    todo = list(parts)
    while todo:
        known |= _summaries(rows, {p: starts[p] for p in todo}, rules, order)
        state, lost, todo = _pack(State()), 0.0, []
        for p in parts:
            start, low, high, end, moved = known[p]
            if start != _unpack(state).key() or not low < lost <= high:
                todo.append(p)
            starts[p] = (state, lost)
            state, lost = end, lost + moved
    schema = "/".join(columns)
    kinds = clean.select(*columns).schema
    from pyspark.sql.types import StringType, StructType

    def verdicts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable")
        state, lost = starts[int(group["part"].iloc[0])]
        out = _run(group, _unpack(state), lost, rules)[0]
        return group[schema.split("/")].assign(verdict=[VERDICTS[v] for v in out])

    return rows.groupBy("part").applyInPandas(verdicts, StructType([*kinds.fields]).add("verdict", StringType()))


def _summaries(rows: DataFrame, starts: dict[int, tuple[dict, float]], rules: Rules, order: tuple[str, ...]) -> dict[int, tuple]:
    """Of each range: start (as a key), low, high, end state, by how much it moves the loss."""
    import json

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable")
        part = int(group["part"].iloc[0])
        state, lost = starts[part]
        _, end, after, low, high = _run(group, _unpack(state), lost, rules)
        return pd.DataFrame({"part": [part], "low": [low], "high": [high], "end": [json.dumps(_pack(end))], "moved": [after - lost]})

    found = rows.filter(F.col("part").isin(list(starts))).groupBy("part").applyInPandas(run, "part int, low double, high double, end string, moved double").collect()
    return {r.part: (_unpack(starts[r.part][0]).key(), r.low, r.high, json.loads(r.end), r.moved) for r in found}
