"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots (a bounded sample of the data) split the data into cells. A summary of each cell - its rows, its radius and its
largest norm - bounds every score in it (q.x <= q.p + |q| radius, and <= |q| norm). Cells are put into parts of bounded
rows, a hot cell into many, and a part is one row: ids, cells and vectors as bytes. Queries travel in blocks of bounded
size, and meet parts by a join on the part's number, so neither side is ever a group in one task, and a part is shuffled
once whatever the number of queries.

A query first goes to the part of its own cell. Its k-th best score there is a floor; then it goes to those parts only
that hold a cell whose bound reaches the floor, skips cells below it there too, and sends back nothing below it. No
candidate is lost, and what is sent back for a query depends on how many scores beat its own cell's, not on the number
of cells.

Cases: vectors that are null, or hold null or non-finite components, take no part; shorter vectors, empty ones too,
count as filled up with zeros; rows that share a vec_id are the same vector's: they are no candidates of each other,
and as a query the least of them stands for all; a null vec_id takes no part; ties go to the smaller vec_id, equal
candidates of one vec_id count once; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens

#: Pivots at most, rows of a part at least and at most (a sixteenth of the table between), queries of a block at most.
MAX_PIVOTS, PART, BLOCK = 1024, (512, 16384), 256


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x: floor(scale * component) of each component, as doubles."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & whole).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("x"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``dim``."""
    n = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _ids(column) -> np.ndarray:
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the smaller id; ``ids`` ascends, each once; scores of own ids, which
    become -inf, and those below ``floor`` are left out."""
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    mine = np.flatnonzero(ids[at] == own)
    scores[mine, at[mine]] = -np.inf
    keep = scores >= floor.astype(scores.dtype)[:, None]
    if scores.shape[1] > k and np.count_nonzero(keep) > 4 * k * len(scores):  # the floor says little
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep &= scores >= least[:, None]
    row, col = np.divmod(np.flatnonzero(keep), keep.shape[1])  # less than half the time of np.nonzero in two dimensions
    finite = np.isfinite(scores[row, col])
    row, col = row[finite], col[finite]
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


class Cells:
    """Summaries of the cells, and the parts they are put into: bounded by the number of pivots, but for hot cells,
    which have a part for each ``size`` rows."""

    def __init__(self, pivots: np.ndarray, cells: list, size: int):
        self.pivots, self.square = pivots, (pivots**2).sum(1)
        self.name = np.array([r["cell"] for r in cells], np.int64)
        self.radius, self.norm = (np.array([r[c] for r in cells], float) for c in ("radius", "norm"))
        self.first, self.parts = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
        part, held = 0, 0
        for r in sorted(cells, key=lambda r: r["cell"]):
            if held and held + r["n"] > size:
                part, held = part + 1, 0
            self.first[r["cell"]] = part
            if (many := -(-r["n"] // size)) > 1:
                self.parts[r["cell"]] = many
                part, held = part + many, 0
            else:
                held += r["n"]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the square of its distance to the pivot."""
        far = (x**2).sum(1)[:, None] + self.square - 2 * x @ self.pivots.T
        cell = far.argmin(1)
        return cell, np.maximum(0, far[np.arange(len(x)), cell])

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The most that each row's inner product with a row of each cell (of ``name``) can be."""
        size = np.sqrt((x**2).sum(1))[:, None]
        most = np.minimum((x @ self.pivots[self.name].T) + size * self.radius, size * self.norm)
        return most + 1e-9 * (size * (self.norm.max(initial=0) + 1) + 1)


def _packed(rows: pa.Table, dim: int, kind: str) -> pa.Table:
    """A part as one row: its vectors by cell, and by id within it."""
    x, ids, cell = _matrix(rows["x"].combine_chunks(), dim), _ids(rows["vec_id"]), _ids(rows["cell"])
    order = np.lexsort((ids, cell))
    new = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
    return pa.table([pa.array([rows["part"][0].as_py()], pa.int64()), pa.array([cell[order][new].tolist()], pa.list_(pa.int32())), pa.array([np.diff(np.append(new, len(ids))).tolist()], pa.list_(pa.int32())), *(pa.array([v.tobytes()], pa.binary()) for v in (ids[order].astype("<i8"), x[order].astype(kind)))], ["part", "cells", "sizes", "ids", "xs"])


def _merged(kept: tuple, more: tuple, k: int) -> tuple:
    """The k best (query, id, score) of each query out of two lists; an id counts once."""
    q, i, s = (np.concatenate(c) for c in zip(kept, more, strict=True))
    order = np.lexsort((-s, i, q))  # an id may lie in several cells: its best score counts
    order = order[np.append(True, (q[order][1:] != q[order][:-1]) | (i[order][1:] != i[order][:-1]))] if len(order) else order
    order = order[np.lexsort((i[order], -s[order], q[order]))]
    q, i, s = q[order], i[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    return q[keep], i[keep], s[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, max_pivots: int = MAX_PIVOTS, part_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` for each of ``queries``; both have
    vec_id and x (doubles that hold integers)."""
    spark = vectors.sparkSession
    scratch.importable(spark)
    vectors = scratch.table(vectors.filter("vec_id is not null").select("vec_id", "x").distinct(), "vectors")
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))).alias("most")).first()
    out = "query_id long, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dim = facts["n"], max(1, facts["dim"])
    if facts["most"] ** 2 * dim >= 2**53:
        raise ValueError("components too large for exact sums in double precision")
    kind = "<f4" if facts["most"] ** 2 * dim < 2**24 else "<f8"  # in which all sums of a score are exact
    part_rows = part_rows or min(PART[1], max(PART[0], n // 16))
    count = max(1, min(max_pivots, n // 128))
    chance = F.xxhash64("vec_id", "x")
    likely = chance <= F.lit(min(2**63 - 1, -(2**63) + 2**64 * (2 * count + 64) // n))  # else each task sends the driver a sample of its own
    sample = vectors.filter(likely).orderBy(chance).limit(count).collect()  # max_pivots at most
    pivots = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        pivots[i, : len(r["x"])] = r["x"]
    near = Cells(np.unique(pivots, axis=0), [], part_rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, 1024):
            x = _matrix(b.column(1), dim)
            cell, far = near.nearest(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(np.sqrt(far)), pa.array(np.sqrt((x**2).sum(1)))], ["vec_id", "x", "cell", "far", "norm"])

    data = scratch.table(vectors.mapInArrow(assign, "vec_id long, x array<double>, cell int, far double, norm double"), "cells")
    found = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).collect()  # a row for each pivot
    cells = Cells(near.pivots, found, part_rows)
    many = {int(c): int(p) for c, p in enumerate(cells.parts) if p > 1}
    first = F.create_map(*(F.lit(v) for r in found for v in (r["cell"], int(cells.first[r["cell"]]))))
    parts = F.coalesce(F.create_map(*(F.lit(v) for kv in many.items() for v in kv))[F.col("cell")], F.lit(1)) if many else F.lit(1)
    placed = data.select("vec_id", "x", "cell", (first[F.col("cell")] + F.pmod(F.xxhash64("vec_id", "x"), parts)).cast("long").alias("part"))
    packed = scratch.table(placed.groupBy("part").applyInArrow(lambda rows: _packed(rows, dim, kind), "part long, cells array<int>, sizes array<int>, ids binary, xs binary"), "parts")

    def own(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The part where each query begins."""
        cell, _ = cells.nearest(x)
        return cells.first[cell] + ids % cells.parts[cell]

    def blocks(to: list[tuple[int, np.ndarray]], ids: np.ndarray, x: np.ndarray, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, q in to:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids[q].astype("<i8"), x[q].astype(kind), floor[q].astype("<f8")))], ["part", "queries", "qs", "floors"])

    def grouped(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries of like cells in blocks: ids, vectors and floors."""
        ids, x, floor = np.asarray(b.column(0)), _matrix(b.column(1), dim), np.asarray(b.column(2).cast(pa.float64()).fill_null(-np.inf))
        order = np.argsort(np.concatenate([cells.nearest(x[lo : lo + BLOCK])[0] for lo in range(0, len(x), BLOCK)] or [np.zeros(0, np.int64)]), kind="stable")
        for lo in range(0, len(order), BLOCK):
            q = order[lo : lo + BLOCK]
            yield ids[q], x[q], floor[q]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, floor in grouped(b):
                part = own(ids, x)
                yield from blocks([(int(p), np.flatnonzero(part == p)) for p in np.unique(part)], ids, x, floor)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, floor in grouped(b):
                reached, part = cells.bounds(x) >= floor[:, None], own(ids, x)
                goes: dict[int, np.ndarray] = {}
                for j, c in enumerate(cells.name.tolist()):
                    for p in range(int(cells.first[c]), int(cells.first[c] + cells.parts[c])):
                        goes[p] = goes.get(p, False) | reached[:, j]
                yield from blocks([(p, q) for p, at in goes.items() if len(q := np.flatnonzero(at & (part != p)))], ids, x, floor)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = {int(c): j for j, c in enumerate(cells.name)}
        for b in tokens.slices(batches, 1):
            names, sizes = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            ids, q, floor = (np.frombuffer(b.column(i)[0].as_buffer(), t) for i, t in ((2, "<i8"), (4, "<i8"), (6, "<f8")))
            xs, qs = (np.frombuffer(b.column(i)[0].as_buffer(), kind).reshape(-1, dim) for i in (3, 5))
            floor, bounds, at = floor.copy(), cells.bounds(qs.astype(float)), 0
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for c, size in zip(names, sizes, strict=True):
                rows, at = slice(at, at + size), at + size
                if not len(pick := np.flatnonzero(bounds[:, column[c]] >= floor)):
                    continue
                scores, own_ids = qs[pick] @ xs[rows].T, ids[rows]
                one = np.flatnonzero(np.append(True, own_ids[1:] != own_ids[:-1]))
                if len(one) < size:
                    scores, own_ids = np.maximum.reduceat(scores, one, axis=1), own_ids[one]
                row, col = _best(scores, own_ids, q[pick], k, floor[pick])
                best = _merged(best, (pick[row], own_ids[col], scores[row, col].astype(np.int64)), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
                floor[full] = np.maximum(floor[full], best[2][np.searchsorted(best[0], full, side="right") - 1])
            yield pa.RecordBatch.from_arrays([pa.array(q[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

    def answers(sent: DataFrame) -> DataFrame:
        # What a block of queries becomes, a row for each part, Spark takes to be as small as the queries: never broadcast it.
        # Sorted, a task holds one part at a time, and queries stream by.
        met = sent.join(packed.hint("merge"), "part").select("cells", "sizes", "ids", "xs", "queries", "qs", "floors")
        return scratch.table(met.mapInArrow(solve, out), "answers")

    asked = scratch.table(queries.filter("vec_id is not null").groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    sent = "part long, queries binary, qs binary, floors binary"
    begun = answers(asked.select("vec_id", "x", F.lit(None).cast("long").alias("floor")).mapInArrow(begin, sent))
    floors = begun.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = answers(asked.join(floors.hint("merge"), "vec_id", "left").select("vec_id", "x", "floor").mapInArrow(go_on, sent))
    best = begun.union(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
