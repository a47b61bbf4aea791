"""Gradient-boosted histogram trees: distributed fit, flattened scoring.

Features are cut into bins at quantiles; a missing value (null or NaN) has a bin of its own. A level of a tree costs one
pass over the rows: each task adds gradients, hessians and counts of its rows into a histogram per node, feature and bin,
Spark adds these up, and the sums - bounded by nodes times features times bins, whatever the rows - decide the splits. A
split also learns to which side missing values go. Predictions so far are kept with the rows and brought up to date every
few trees, so a pass walks only the trees since then.

A fitted :class:`Forest` is a table of nodes. Scoring walks it level by level for a whole Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept

#: Trees between two writes of the predictions so far.
EVERY = 8


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, one after the other; ``roots`` says where trees begin. ``x <= threshold`` goes left, a missing
    value where ``missing_left`` says. A leaf (feature -1) has a value; a score is ``base`` and the values reached."""

    features: tuple[str, ...]
    base: float
    logistic: bool
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, features: list[str], trees: list[list[tuple]], base: float = 0.0, logistic: bool = False) -> Forest:
        """From nodes (feature name, threshold, missing_left, left, right) and leaves (value,), places within their tree."""
        roots = np.cumsum([0, *(len(t) for t in trees)])[:-1]
        rows = [(-1, 0.0, False, k, k, n[0]) if len(n) == 1 else (features.index(n[0]), n[1], n[2], at + n[3], at + n[4], 0.0) for at, t in zip(roots.tolist(), trees, strict=True) for k, n in enumerate(t, at)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (np.int32, np.float64, bool, np.int64, np.int64, np.float64)
        return cls(tuple(features), base, logistic, roots.astype(np.int64), *(np.array(c, k) for c, k in zip(cols, kinds, strict=True)))

    def walk(self, x: np.ndarray, since: int = 0) -> np.ndarray:
        """Sums of the leaves' values of the trees from ``since`` on, for rows of ``x`` (NaN: missing)."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots[since:].tolist():
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                v = x[rows, np.maximum(self.feature[at], 0)]
                goes = np.where(np.isnan(v), self.missing_left[at], v <= self.threshold[at])
                at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
            total += self.value[at]
        return total

    def sql(self, names: dict[str, str] | None = None) -> str:
        """The raw score as an SQL expression, for engines that have no such table."""

        def node(k: int) -> str:
            if self.feature[k] < 0:
                return repr(float(self.value[k]))
            c = (names or {}).get(self.features[self.feature[k]], self.features[self.feature[k]])
            side = "TRUE" if self.missing_left[k] else "FALSE"
            return f"CASE WHEN coalesce({c} <= CAST('{float(self.threshold[k])!r}' AS DOUBLE), {side}) THEN {node(self.left[k])} ELSE {node(self.right[k])} END"

        return " + ".join([repr(float(self.base)), *(f"({node(int(r))})" for r in self.roots)])

    def rows(self) -> list[tuple]:
        """The node table as rows: tree, node, feature, threshold, missing_left, left, right, value."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        name = lambda k: self.features[k] if k >= 0 else None
        return [(int(t), k, name(f), float(h), bool(m), int(a), int(b), float(v)) for k, (t, f, h, m, a, b, v) in enumerate(zip(tree, self.feature, self.threshold, self.missing_left, self.left, self.right, self.value, strict=True))]


def _matrix(b: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Doubles, NaN where a value is missing."""
    return np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]) if names else np.zeros((b.num_rows, 0))


def score(forest: Forest, rows: DataFrame, name: str = "score") -> DataFrame:
    """``rows`` with the forest's score: a probability if it is logistic. Extra columns pass through."""
    rows = rows.drop(name).withColumns({c: F.col(c).cast("double") for c in forest.features})
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = forest.base + forest.walk(_matrix(b, forest.features))
            got = 1 / (1 + np.exp(-raw)) if forest.logistic else raw
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*columns, name])

    from pyspark.sql.types import DoubleType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(name, DoubleType()))


def edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Where the bins of each feature end: quantiles of its values, missing ones apart."""
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = rows.agg(*(F.percentile_approx(clean(c), shares, F.lit(100 * bins)).alias(f"e{i}") for i, c in enumerate(features))).first()
    return [np.unique(np.array(found[f"e{i}"] or [], float)) for i in range(len(features))]


#: Rows of the state: blocks of y, of the scores so far, and of bins (feature by feature).
STATE = "y binary, raw binary, bins binary"


def _block(y: np.ndarray, raw: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.astype(kind, copy=False).tobytes()], pa.binary()) for x, kind in ((y, "<f8"), (raw, "<f8"), (bins, "<i2"))], ["y", "raw", "bins"])


def _binned(rows: DataFrame, features: list[str], label: str | Column, cuts: list[np.ndarray], base: float) -> DataFrame:
    """:data:`STATE`: y, raw (the score so far) and bins (of each feature; the number of cuts and one: missing)."""
    y = (F.col(label) if isinstance(label, str) else label).cast("double").alias("y")
    names = tuple(f"f{i}" for i in range(len(features)))
    picked = rows.select(y, *(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True))).filter("y IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, names)
            bins = np.stack([np.where(np.isnan(x[:, k]), len(c) + 1, np.searchsorted(c, x[:, k])) for k, c in enumerate(cuts)])
            yield _block(b.column("y").to_numpy(), np.full(b.num_rows, base), bins)

    return picked.mapInArrow(run, STATE)


def _opened(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for y, raw, bins in zip(*(b.column(c) for c in ("y", "raw", "bins")), strict=True):
            yield np.frombuffer(y.as_buffer(), "<f8"), np.frombuffer(raw.as_buffer(), "<f8"), np.frombuffer(bins.as_buffer(), "<i2").reshape(n, -1)


class _Walk:
    """A forest whose thresholds are cuts, walked by bins: where each bin goes from each node is looked up."""

    def __init__(self, forest: Forest, cuts: list[np.ndarray]):
        self.forest, self.wide = forest, max(len(c) for c in cuts) + 2
        self.to = np.repeat(np.arange(len(forest.feature)), self.wide).reshape(-1, self.wide)
        for k in np.flatnonzero(forest.feature >= 0).tolist():
            c = cuts[forest.feature[k]]
            goes = np.arange(self.wide) <= np.searchsorted(c, forest.threshold[k])
            goes[len(c) + 1] = forest.missing_left[k]
            self.to[k] = np.where(goes, forest.left[k], forest.right[k])
        self.to, self.feature = self.to.ravel(), np.maximum(forest.feature, 0).astype(np.int64)
        self.inner = forest.feature >= 0

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        n = bins.shape[1]
        total, rows, flat = np.zeros(n), np.arange(n), bins.ravel()
        for root in self.forest.roots.tolist():
            at = np.full(n, root)
            while self.inner[at].any():
                at = self.to[at * self.wide + flat[self.feature[at] * n + rows]]
            total += self.forest.value[at]
        return total


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int = -1
    cut: int = 0
    missing_left: bool = True


def best_split(hist: np.ndarray, cuts: list[np.ndarray], l2: float, least: int) -> Split:
    """Of one node: hist has (gradient, hessian, count) by feature and bin. Every cut is tried with missing values on
    either side; without any, they go where more rows go."""
    best = Split(1e-12)
    for f, c in enumerate(cuts):
        h = hist[f, : len(c) + 2]
        total, missing = h.sum(0), h[len(c) + 1]
        part = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
        low = np.cumsum(h[: len(c) + 1], axis=0)[: len(c)]
        for goes_left in (True, False) if missing[2] else (None,):
            left = low + missing if goes_left else low
            right = total - left
            gain = part(left) + part(right) - part(total)
            gain[(left[:, 2] < least) | (right[:, 2] < least)] = -np.inf
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best.gain:
                best = Split(float(gain[k]), f, k, bool(left[k, 2] > right[k, 2]) if goes_left is None else goes_left)
    return best


def fit(rows: DataFrame, features: list[str], label: str = "y", logistic: bool = True, trees: int = 50, depth: int = 3, rate: float = 0.1, l2: float = 1.0, least: int = 20, bins: int = 64, cuts: list[list[float]] | None = None) -> Forest:
    """Boosted trees for 0/1 labels (``logistic``) or for values (squared error).

    ``rate`` shrinks leaves, ``l2`` is added to their hessians, a leaf has ``least`` rows at least. ``cuts`` gives the ends
    of bins instead of quantiles. Rows without a label are left out; missing features are routed. Without rows, or with one
    class only, the forest is its base.
    """
    ends = [np.unique(np.array(c, float)) for c in cuts] if cuts is not None else edges(rows, features, bins)
    n, mean = rows.filter(F.col(label).isNotNull()).agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
    mean = mean or 0.0
    if not n or logistic and not 0 < mean < 1:
        return Forest.of(features, [], (0.0 if not n else 50.0 if mean else -50.0) if logistic else mean, logistic)
    base = float(np.log(mean / (1 - mean))) if logistic else float(mean)
    state = kept(_binned(rows, features, label, ends, base))
    done: list[list[tuple]] = []
    written = 0
    for _ in range(trees):
        nodes: list[tuple] = [(0.0,)]
        level = [0]
        for d in range(depth + 1):
            forest = Forest.of(features, done[written:], 0.0, logistic)
            hist = _histograms(state, forest, Forest.of(features, [[n if len(n) > 1 else (float(k),) for k, n in enumerate(nodes)]]), level, ends, logistic)
            grown = []
            for k, h in zip(level, hist, strict=True):
                total = h[0].sum(0)
                split = best_split(h, ends, l2, least) if d < depth else Split(0.0)
                if split.feature < 0:
                    nodes[k] = (float(-rate * total[0] / (total[1] + l2)),)
                    continue
                nodes[k] = (features[split.feature], float(ends[split.feature][split.cut]), split.missing_left, len(nodes), len(nodes) + 1)
                grown += [len(nodes), len(nodes) + 1]
                nodes += [(0.0,), (0.0,)]
            level = grown
            if not level:
                break
        done.append(nodes)
        if len(done) - written == EVERY:
            state, written = kept(_stepped(state, Forest.of(features, done[written:]), ends)), len(done)
    return replace(Forest.of(features, done, base, logistic))


def _stepped(state: DataFrame, forest: Forest, cuts: list[np.ndarray]) -> DataFrame:
    """``state`` with the forest's trees in its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(forest, cuts)
        for y, raw, bins in _opened(batches, len(cuts)):
            yield _block(y, raw + walk(bins), bins)

    return state.mapInArrow(run, STATE)


def _histograms(state: DataFrame, forest: Forest, tree: Forest, level: list[int], cuts: list[np.ndarray], logistic: bool) -> np.ndarray:
    """Sums of gradient, hessian and rows by node of ``level``, feature and bin. ``tree``: its leaves hold their numbers."""
    wide = max(len(c) for c in cuts) + 2
    place = np.full(len(tree.feature) + 1, -1)
    place[level] = np.arange(len(level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(level) * len(cuts) * wide, 3))
        before, now = _Walk(forest, cuts), _Walk(tree, cuts)
        for y, raw, bins in _opened(batches, len(cuts)):
            raw = raw + before(bins)
            node = place[now(bins).astype(np.int64)]
            p = 1 / (1 + np.exp(-raw)) if logistic else raw
            g, h, on = p - y, p * (1 - p) if logistic else np.ones(len(y)), node >= 0
            if not on.all():
                g, h, node, bins = g[on], h[on], node[on], bins[:, on]
            for f in range(len(cuts)):
                at = (node * len(cuts) + f) * wide + bins[f]
                for v, values in enumerate((g, h, None)):
                    total[:, v] += np.bincount(at, values, len(total))
        at = np.flatnonzero(total[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, v]) for v in range(3))], ["at", "g", "h", "n"])

    sums = state.mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()  # nodes x features x bins
    out = np.zeros((len(level) * len(cuts) * wide, 3))
    for at, *v in sums:
        out[at] = v
    return out.reshape(len(level), len(cuts), wide, 3)
